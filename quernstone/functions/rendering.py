"""Results as clients get them: pairs, trees, JSON lines of a feed."""

from __future__ import annotations

import json
from collections.abc import Iterator

from ..types import render


def pairs(rows: list) -> list[dict]:
    """Association rows (from_id, to_id)."""
    return [{"from": render(r["from_id"], None), "to": render(r["to_id"], None)} for r in rows]


def tree(rows: list, identity: str) -> dict:
    """Rows of a shortest-path tree: the roots' ids and all nodes."""
    hidden = ("_depth", "_parent")
    nodes = [{**{k: render(v, None) for k, v in r.asDict().items() if k not in hidden}, "depth": r["_depth"], "parent": r["_parent"]} for r in rows]
    return {"roots": [r[identity] for r in rows if r["_depth"] == 0], "nodes": nodes}


def ndjson(engine, subject: str, name: str, cursor: str | None = None, batch: int = 256, follow: int = 1) -> Iterator[str]:
    """A change feed as lines: each event, and the cursor after each batch, which
    the client keeps.  follow: how many empty polls to wait through."""
    while True:
        rows, after = engine.changes(subject, name, cursor, limit=batch)
        for r in rows:
            yield json.dumps({k: render(v, None) for k, v in r.items()})
        if after != cursor:
            yield json.dumps({"cursor": after})
            cursor = after
        else:
            follow -= 1
            if follow <= 0:
                return
