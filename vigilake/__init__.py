"""Security analytics over logs and streams of AI-agent events, as Spark jobs."""
