"""inkloom: manuscript analytics as Spark queries."""
