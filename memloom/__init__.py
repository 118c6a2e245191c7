"""memloom: agent-memory and corpus data jobs as PySpark DataFrame programs."""
