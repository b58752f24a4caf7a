"""quillstream: a semantic, event-sourced analytics engine written as Spark plans."""
