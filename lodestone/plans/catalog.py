"""All registered queries of the library outside the training-data subpackage, and their SQL."""

from . import records, retrieval, standards

QUERIES = {**standards.QUERIES, **retrieval.QUERIES, **records.QUERIES}
SQL = {**standards.SQL, **retrieval.SQL, **records.SQL}
