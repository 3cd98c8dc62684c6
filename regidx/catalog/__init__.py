"""Every registered query with its check SQL (None where SQL is no practical check)."""

from regidx.catalog import index_queries, registry_queries, retrieval_queries, source_queries

CATALOGUE = {
    **registry_queries.QUERIES,
    **index_queries.QUERIES,
    **retrieval_queries.QUERIES,
    **source_queries.QUERIES,
}
