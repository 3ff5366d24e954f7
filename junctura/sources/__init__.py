"""Readers of aligner output: matrices, barcode and feature lists, junction tables, spatial positions."""

from .readers import read_genes, read_junctions, read_velocity

__all__ = ["read_genes", "read_junctions", "read_velocity"]
