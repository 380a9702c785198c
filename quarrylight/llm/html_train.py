"""Trains the block labeller: ``python -m quarrylight.llm.html_train``.

Pages are made up from page furniture and articles in many shapes, each block
marked as article text or not; no page of any table is used.  The network is
fitted by back-propagation through time and Adam, and its weights written
beside :mod:`quarrylight.llm.html_text`.
"""

from __future__ import annotations

import random

import numpy as np

from quarrylight.llm import html_text
from quarrylight.llm.html_text import DIMS, HIDDEN, WEIGHTS, Labeller, _sigmoid

#: Names that sites give to what surrounds an article, and to the article.
AROUND = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu tabs toc pagination pager".split(),
    "header": "header masthead banner topbar site branding logo hero".split(),
    "footer": "footer copyright bottom colophon legal credits sitefooter".split(),
    "aside": "sidebar aside related recommended widget rail trending popular tags share social archive".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion banner adsense sponsor".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall message".split(),
    "form": "form search login signup newsletter subscribe subscription contact".split(),
    "comments": "comments comment discussion responses reply replies disqus feedback thread".split(),
}
ARTICLE = "article content main post entry body story text page blog document maincontent articlebody".split()
LABELS = {
    "nav": "Home About Contact News Products Services Blog Help Archive Next Previous Menu".split(),
    "header": ["Daily News", "Welcome", "The Site", "Log in", "Search"],
    "footer": ["© 2024 Example Ltd", "All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "© example.org · Some words here."],
    "aside": ["Related articles", "Most read", "Share this", "Tags", "You may also like"],
    "ad": ["Advertisement", "Buy now and save.", "Sponsored", "Limited offer, click here!"],
    "notice": ["We use cookies to improve this site.", "Accept all", "This site uses cookies.", "Please turn off your ad blocker."],
    "form": ["Name", "E-mail", "Send", "Subscribe to our newsletter", "Search", "Password"],
    "comments": ["3 comments", "Leave a reply", "Reply", "Anonymous says:", "Posted by a reader"],
}


class Maker:
    """Random pages as html with a mark before every block: \x01 for article text, \x02 for the rest."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = ["aeiou", "bcdfghlmnprstvw"]
        self.vocabulary = ["".join(self.r.choice(letters[(i + j) % 2]) for i in range(self.r.randint(2, 9))) for j in range(3000)]
        self.vocabulary += ["éa" + w for w in self.vocabulary[:300]] + ["the", "of", "and", "to", "de", "la", "der", "und"] * 20

    def words(self, lo: int, hi: int, link: float = 0.0) -> str:
        mark = self.r.random()
        tail = self.r.choice(["%%%", "***", "###", "$$$", "&amp;"]) if mark < 0.05 else " |" if mark < 0.1 else "!!" if mark < 0.12 else ""
        out, start = [], True
        if hi > 20 and self.r.random() < 0.04:  # a very long block, or one word over and over
            lo, hi = hi, 20 * hi
        few = [self.r.choice(self.vocabulary)] if self.r.random() < 0.03 else self.vocabulary
        for _ in range(self.r.randint(lo, hi)):
            w = self.r.choice(few)
            w = w.capitalize() if start else w
            start = self.r.random() < 0.12
            w = w + tail + ("." if start else "," if self.r.random() < 0.05 else "")
            out.append(f'<a href="/{w[:3]}">{w}</a>' if self.r.random() < link else f"<b>{w}</b>" if self.r.random() < 0.01 else w)
        return " ".join(out) + ("." if self.r.random() < 0.8 else "")

    def attributes(self, names: list[str]) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        name = r.choice(names)
        if r.random() < 0.4:
            name += r.choice(["-", "_", " "]) + r.choice(["box", "wrap", "inner", "list", "item", "left", "x1", "area", "block", "container"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def around(self, kind: str) -> str:
        r = self.r
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if semantic and r.random() < 0.65:
            tag, attributes = semantic, self.attributes(AROUND[kind]) if r.random() < 0.5 else ""
        else:
            tag, attributes = r.choice(["div", "div", "section", "aside" if kind != "header" else "div"]), f' class="{r.choice(AROUND[kind])}"'
        own = lambda: r.choice(LABELS[kind]) if r.random() < 0.5 else self.words(1, 4)
        inside = []
        if kind == "nav" or (kind in ("aside", "footer", "header") and r.random() < 0.5):
            item = lambda: f'<li>\x02<a href="/{r.randint(0, 99)}">{own()}</a></li>'
            items = "".join(item() for _ in range(r.randint(2, 9)))
            inside.append(f"<ul>{items}</ul>" if r.random() < 0.8 else "".join(f'<div>\x02<a href="#">{own()}</a></div>' for _ in range(4)))
        if kind == "comments":
            inside += [f"<h3>\x02{own()}</h3>"] + [f'<{x}{self.attributes(AROUND[kind])}><p>\x02{self.words(3, 60)}</p></{x}>' for x in [r.choice(["div", "li", "article", "p"]) if r.random() < 0.7 else "div"] for _ in range(r.randint(1, 6))]
        if kind == "form":
            inside += [f"<label>\x02{own()}</label><input><br>" for _ in range(r.randint(1, 4))] + [f"<button>\x02{own()}</button>"]
        if kind in ("ad", "notice", "footer", "header", "aside") and (not inside or r.random() < 0.5):
            wrap = r.choice(["", "", "p", "h3", "div", "span"])
            for _ in range(r.randint(1, 3) if wrap in ("p", "div", "h3") else 1):
                body = self.words(2, 25, 0.1) if r.random() < 0.6 else own()
                body = "&copy; " + self.r.choice(["www.", ""]) + "example.org &middot; " + body if kind == "footer" and r.random() < 0.5 else body
                inside.append(f"<{wrap}>\x02{body}</{wrap}>" if wrap else "\x02" + body)
        return f"<{tag}{attributes}>{''.join(inside)}</{tag}>"

    def article(self) -> str:
        r = self.r
        tag, attributes = r.choice([("article", ""), ("article", ""), ("article", None), ("main", None), ("div", None), ("section", None)])
        if attributes is None:
            attributes = f' {r.choice(["class", "id"])}="{r.choice(ARTICLE)}"'
        parts = []
        if r.random() < 0.85:
            parts.append(f"<h1>\x01{self.words(1, 12)}</h1>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12, 20, 20, 60])):
            x = r.random()
            if x < 0.66:
                parts.append(f"<p>\x01{self.words(1, 90, 0.02)}</p>")
            elif x < 0.76:
                parts.append(f"<p><b>\x01{self.words(1, 60)}<br>")
            elif x < 0.82:
                parts.append(f"<h{r.choice('23')}>\x01{self.words(1, 8)}</h{r.choice('23')}>")
            elif x < 0.87:
                parts.append("<ul>" + "".join(f"<li>\x01{self.words(1, 20)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif x < 0.9:
                parts.append(f"<blockquote>\x01{self.words(5, 40)}</blockquote>")
            elif x < 0.92:
                parts.append(f"<pre>\x01{self.words(3, 30)}</pre>")
            elif x < 0.94:
                parts.append("<table><tr>" + "".join(f"<td>\x01{self.words(1, 5)}</td>" for _ in range(r.randint(2, 6))) + "</tr></table>")
            elif x < 0.96:
                parts.append(f"<figure><img src='x'><figcaption>\x01{self.words(2, 12)}</figcaption></figure>")
            elif x < 0.98:
                parts.append(self.around("ad"))
            else:
                parts.append(self.around("aside"))
        if r.random() < 0.05:
            parts.append(self.around("comments"))
        if r.random() < 0.05:
            parts.append(self.around("form"))
        return f"<{tag}{attributes}>{''.join(parts)}</{tag}>"

    def page(self) -> str:
        r = self.r
        some = lambda kinds, p: [self.around(k) for k in kinds if r.random() < p]
        before = some(["header"], 0.5) + some(["nav"], 0.8) + some(["notice", "ad", "form", "aside"], 0.3)
        after = some(["aside", "ad", "form", "notice"], 0.25) + some(["comments"], 0.35) + some(["nav"], 0.2) + some(["footer"], 0.85)
        middle = self.article() if r.random() < 0.97 else ""
        if r.random() < 0.3:
            middle = f'<div class="{r.choice(["wrap", "container", "row", "page", "layout"])}">{middle}{self.around("aside") if r.random() < 0.4 else ""}</div>'
        body = "".join(before) + middle + "".join(after)
        return f"<html><head><title>t</title></head><body>{body}" + ("</body></html>" if r.random() < 0.7 else "")


def examples(maker: Maker, n: int):
    """Vectors, page starts and marks of n made-up pages."""
    blocks, marks, first = [], [], [0]
    for _ in range(n):
        own = html_text.leaf_blocks(maker.page())
        for b in own:
            marks.append(b.text[0] == "\x01" if b.text[0] in "\x01\x02" else "\x01" in b.text)
            b.text = b.text.replace("\x01", "").replace("\x02", "").strip() or "x"
        blocks += own
        first.append(len(blocks))
    first = np.array(first)
    return html_text.vectors(blocks, html_text.shares(first)), first, np.array(marks, np.float32)


def _steps(x: np.ndarray, wh: np.ndarray):
    """As html_text.lstm, with what the way back needs."""
    pages, steps, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    kept, out = [], np.empty((pages, steps, HIDDEN), np.float32)
    for t in range(steps):
        g = x[:, t] + h @ wh
        s, u = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        before = (h, c)
        c = s[:, :HIDDEN] * c + s[:, HIDDEN : 2 * HIDDEN] * u
        h = s[:, 2 * HIDDEN :] * np.tanh(c)
        kept.append((*before, s, u, c))
        out[:, t] = h
    return out, kept


def _back(d_out: np.ndarray, kept: list, wh: np.ndarray):
    """Gradients of the gates' inputs and of the recurrent weights."""
    pages, steps, _ = d_out.shape
    dx, dwh = np.empty((pages, steps, 4 * HIDDEN), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h0, c0, s, u, c = kept[t]
        forget, enter, leave = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        dh = dh + d_out[:, t]
        th = np.tanh(c)
        dc = dc + dh * leave * (1 - th * th)
        gates = np.concatenate([dc * c0 * forget * (1 - forget), dc * u * enter * (1 - enter), dh * th * leave * (1 - leave), dc * enter * (1 - u * u)], 1)
        dx[:, t] = gates
        dwh += h0.T @ gates
        dh, dc = gates @ wh.T, dc * forget
    return dx, dwh


def train(pages: int = 6000, rounds: int = 8, batch: int = 64, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    x, first, y = examples(Maker(seed), pages)
    init = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    w = {"fx": init(DIMS, 4 * HIDDEN), "fh": init(HIDDEN, 4 * HIDDEN), "bx": init(DIMS, 4 * HIDDEN), "bh": init(HIDDEN, 4 * HIDDEN), "of": init(HIDDEN), "ob": init(HIDDEN), "o": np.zeros((), np.float32)}
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    sizes = np.diff(first)
    for turn in range(rounds):
        order = np.argsort(sizes + rng.random(len(sizes)) * 6)  # pages of like length together
        order = order[sizes[order] > 0]
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            own = groups[g]
            n, steps = sizes[own][:, None], sizes[own].max()
            step_at = np.arange(steps)[None, :]
            real = (step_at < n).astype(np.float32)
            ahead = first[own][:, None] + np.minimum(step_at, n - 1)
            flip = np.where(step_at < n, n - 1 - step_at, step_at)
            xa = x[ahead]
            xb = np.take_along_axis(xa, flip[:, :, None], 1)
            f, kf = _steps(xa @ w["fx"], w["fh"])
            b, kb = _steps(xb @ w["bx"], w["bh"])
            turned = np.take_along_axis(b, flip[:, :, None], 1)
            z = f @ w["of"] + turned @ w["ob"] + w["o"]
            dz = (_sigmoid(z) - y[ahead]) * real / real.sum()
            dxf, dfh = _back(dz[:, :, None] * w["of"], kf, w["fh"])
            dxb, dbh = _back(np.take_along_axis(dz[:, :, None] * w["ob"], flip[:, :, None], 1), kb, w["bh"])
            grad = {"fx": np.einsum("pti,ptj->ij", xa, dxf), "fh": dfh, "bx": np.einsum("pti,ptj->ij", xb, dxb), "bh": dbh, "of": np.einsum("pt,pth->h", dz, f), "ob": np.einsum("pt,pth->h", dz, turned), "o": dz.sum()}
            step += 1
            pace = 0.01 * (1 - turn / rounds)
            for k, a in grad.items():
                a = np.clip(a, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.999 * v[k] + 0.001 * a * a
                w[k] = (w[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"round {turn}: training {accuracy(w, x, first, y):.5f}")
    return w


def accuracy(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> float:
    return float(((Labeller(w).chances(x, first) >= 0.5) == (y > 0)).mean())


if __name__ == "__main__":
    weights = train()
    print(f"held out: {accuracy(weights, *examples(Maker(99), 1500)):.5f}")
    np.savez_compressed(WEIGHTS, **weights)
