"""trawl: secret detection and triage over large text corpora, as Spark DataFrame jobs."""
