"""All registered queries."""

from freshet.plans import changes, feeds, health, keyed, reads, streams, texts

MODULES = (reads, changes, health, texts, feeds, streams, keyed)
QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
