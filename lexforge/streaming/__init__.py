"""Stream operators: keyed running lengths, affinities, routing and upserting sinks."""
