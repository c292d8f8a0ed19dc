"""Query plans, the admission-controlled runner, benchmarks and traces."""
