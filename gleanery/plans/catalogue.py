"""Every query by name, with the SQL that it is held against."""

from . import rows, texts

_ALL = texts.QUERIES | rows.QUERIES
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLE = {k: sql for k, (_, sql) in _ALL.items() if sql}
