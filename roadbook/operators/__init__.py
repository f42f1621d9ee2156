"""DataFrame-to-DataFrame operators; none of them reads, writes or collects."""
