"""All catalogue queries by name."""

from tallyback.catalog_models import QUERIES as MODELS
from tallyback.catalog_retention import QUERIES as RETENTION
from tallyback.catalog_returns import QUERIES as RETURNS

QUERIES = {**RETURNS, **RETENTION, **MODELS}
