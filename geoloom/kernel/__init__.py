"""Geometry kernel in numpy and the standard library: codecs, measures, overlay, buffers, projections."""
