"""Tarnwood: hybrid retrieval, corpus analytics and data repair as Spark plans."""
