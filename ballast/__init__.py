"""ballast: rail-corridor terrain analytics and corpus operators on Spark."""
