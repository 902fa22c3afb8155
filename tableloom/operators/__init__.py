"""DataFrame-to-DataFrame operators: aggregate, dedup, enrich, bars, listing, key pools."""
