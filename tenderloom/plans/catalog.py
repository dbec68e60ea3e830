"""All registered procurement queries and their SQL."""

from __future__ import annotations

from tenderloom.plans import more, queries, sql
from tenderloom.plans import contexts as _contexts  # noqa: F401  registers its queries in `more`
from tenderloom.plans import deep as _deep  # noqa: F401  registers its queries in `more`
from tenderloom.plans import rows as _rows  # noqa: F401  registers its queries in `more`
from tenderloom.plans import structures as _structures  # noqa: F401  likewise
from tenderloom.plans import texts as _texts  # noqa: F401  likewise

QUERIES = queries.QUERIES | more.QUERIES
ORACLE_SQL = sql.ORACLE_SQL | {name: more.with_views(text) for name, text in more.SQL.items()}
