"""Anonymisation of dated, firm-tagged text and an audit of how well it worked, as Spark jobs."""
