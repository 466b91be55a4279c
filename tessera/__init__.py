"""tessera: sequence-count analytics and finite-sum model fitting as Spark jobs."""
