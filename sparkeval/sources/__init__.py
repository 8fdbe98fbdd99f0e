"""Reading corpora, benchmarks and completions; writing reports and logs."""
