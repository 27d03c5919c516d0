"""feedloom: analytics over semi-structured record feeds, as Spark plans."""
