"""DataFrame operators over nodes, lines, tables, postings, vectors, graphs and answers."""
