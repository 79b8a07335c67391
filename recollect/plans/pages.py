"""Pages of a store's documents that a writer cannot shift.

A cursor holds where the last page ended and the segments it was read from.
These stay as they are until ``vacuum``, so the pages of one cursor are of one
version, whatever is committed meanwhile; each is read by its keys and not by
counting rows.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.plans.store import Store

COLUMNS = ("id", "title", "source", "content_type", "chunk_count", "created_at", "updated_at")
#: The most rows of a page.
MOST = 1000


def _after(updated_at: int, id: str):
    """Rows behind a place in the order: newest first, then by id."""
    return (F.col("updated_at") < updated_at) | ((F.col("updated_at") == updated_at) & (F.col("id") > id))


def document_pages(store: Store, limit: int = 100, cursor: str | None = None) -> tuple[list[dict], str | None]:
    """(rows of a page, cursor of the next one or None at the end)."""
    limit = max(1, min(MOST, limit))
    if cursor is None:
        at, place = store.manifest()["tables"].get("documents", []), None
    else:
        try:
            at, *place = json.loads(base64.urlsafe_b64decode(cursor))
        except ValueError as e:
            raise ValueError("no cursor of this store") from e
    rows: DataFrame = store.read_segments("documents", at).select(*COLUMNS)
    if place:
        rows = rows.where(_after(*place))
    got = [r.asDict() for r in rows.orderBy(F.desc("updated_at"), "id").limit(limit + 1).collect()]  # MOST + 1 at most
    page, more = got[:limit], len(got) > limit
    last = page[-1] if more else None
    return page, base64.urlsafe_b64encode(json.dumps([at, last["updated_at"], last["id"]]).encode()).decode() if last else None
