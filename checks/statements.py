"""All DuckDB check statements by catalogue name."""

from checks.models_sql import SQL as MODELS_SQL
from checks.retention_sql import SQL as RETENTION_SQL
from checks.returns_sql import SQL as RETURNS_SQL

SQL = {**RETURNS_SQL, **RETENTION_SQL, **MODELS_SQL}
