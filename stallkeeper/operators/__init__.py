"""Table operators: dictionaries, prices, deals, reports, feeds, tiles, enrichment."""
