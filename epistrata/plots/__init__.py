"""Drawings of small results as SVG, and reports that hold them."""
