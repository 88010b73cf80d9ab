"""All registered queries by operator id."""

from __future__ import annotations

from roostline.standins import answers, ingest, search, snapshot

QUERIES = {**ingest.QUERIES, **snapshot.QUERIES, **search.QUERIES, **answers.QUERIES}
flagship = search.flagship
