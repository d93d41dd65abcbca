"""Relational operators over tables of files, edges and declarations."""
