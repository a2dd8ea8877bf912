"""Schemas of the tables that stages pass on."""

ALIGNMENTS = "contig string, start int, end int, read string, mapq int, strand string, line_no long"
CONTIGS = "contig string, length int"
LINKS = "link_id long, a string, oa string, b string, ob string, mean double, stdev double"
BUNDLED = LINKS + ", bsize int"
COVERAGE = "contig string, coverage double"
ORIENTATION = "contig string, orient string, invalidated long"
BLOCKS = "component string, block int, members array<string>"
BUBBLES = "component string, source string, sink string, members array<string>"
