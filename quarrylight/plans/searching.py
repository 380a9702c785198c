"""Full-text indexes of a store's tables, kept beside it and brought up to date from its layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators import search
from quarrylight.sources import fulltext
from quarrylight.sources.store import Store

#: Tables with an index: the id of a document, and its text columns.
INDEXED = {"file_content": ("file_id", ["text"]), "symbol": ("id", ["name", "qualified_name", "signature", "documentation"])}


def text_index(store: Store, name: str, workspace_id: int) -> fulltext.TextIndex:
    return fulltext.TextIndex(store.spark, f"{store.root}/fulltext/{name}/{workspace_id}", INDEXED[name][1], folded=True)


def _layers(store: Store, name: str, workspace_id: int, manifest: dict | None = None) -> list[dict]:
    return (store.manifest() if manifest is None else manifest).get(name, {}).get(str(workspace_id), [])


def refresh(store: Store, workspace_id: int, names: list[str] | None = None) -> dict[str, int]:
    """Brings a workspace's indexes up to the store's version; returns how many layers of each table were new.

    An index notes the layers that it was made from.  Where the table has gained
    layers since, their rows and deletion marks are all that is read; where
    layers have been merged, files that differ are found by their hashes.
    """
    new, manifest = {}, store.manifest()
    for name in names or INDEXED:
        id_col, _ = INDEXED[name]
        layers, index = store.layers(name), text_index(store, name, workspace_id)
        now, then = _layers(store, name, workspace_id, manifest), index.state()["note"] or []
        if now == then:
            continue
        if now[: len(then)] == then:
            fresh = now[len(then) :]
            docs, marks = layers.visible(fresh), layers.gone(fresh)
            keys = marks.select(F.col("_key").alias(layers.key)) if marks is not None else None
        else:
            keys = layers.changed(then, layers.visible(now))
            docs = layers.visible(now).join(keys, layers.key, "left_semi")
        old = layers.visible(then).join(keys, layers.key, "left_semi").select(id_col) if then and keys is not None else None
        index.commit(docs, id_col, old, note=now)
        new[name] = len(now) - len(then)
    return new


def hits(store: Store, name: str, workspaces: list[int], query: search.Query, rows: DataFrame) -> DataFrame:
    """(id, rank) of a table's rows in some workspaces, from their indexes where all are up to date, else from ``rows`` themselves."""
    id_col, columns = INDEXED[name]
    indexes, manifest = [text_index(store, name, ws) for ws in workspaces], store.manifest()
    states = [x.state() for x in indexes]
    if all((s["note"] or []) == _layers(store, name, ws, manifest) for s, ws in zip(states, workspaces, strict=True)):
        return fulltext.search(indexes, query, states)
    return search.search(rows, query, id_col, columns, folded=True)
