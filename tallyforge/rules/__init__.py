"""Rule tables of fixed size: languages, vendored paths, generated files, licenses."""
