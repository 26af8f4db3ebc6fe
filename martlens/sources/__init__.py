"""Where tables come from: raw files, stored marts, the catalog, literals."""
