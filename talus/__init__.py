"""talus: conversational-corpus retrieval and corpus preparation on Apache Spark."""
