"""Readers and writers: tables, office documents, web pages, glossaries."""
