"""Named queries over the star-schema and corpus tables; importing this package registers them."""

from trellis.plans import corpus_queries, feed_queries, gate_queries, graph_queries, knowledge_base, relational, source_queries  # noqa: F401
