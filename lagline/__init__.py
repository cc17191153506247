"""Point-in-time features and ranked scores over event streams, as Spark plans."""
