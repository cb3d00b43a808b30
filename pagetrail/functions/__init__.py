"""Column functions: urls, identifiers, text and HTML, as expressions that Catalyst sees through."""
