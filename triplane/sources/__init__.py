"""Where triples come from: mapped tables, RDF files, the encoded store."""
