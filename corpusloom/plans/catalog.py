"""All queries of the library by name, with their oracle SQL."""

from __future__ import annotations

from corpusloom.plans import aggregates, anchoring, api, assembly, bills, binding, boxes, citations, definitions, gates, grammar, headings, joins, lookups, markup, ordered, search, streams, structure, texts

MODULES = (search, joins, binding, grammar, citations, structure, anchoring, definitions, boxes, gates, lookups, aggregates, ordered, texts, markup, api, streams, bills, headings, assembly)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
FLAGSHIP = QUERIES["search_sections"]
