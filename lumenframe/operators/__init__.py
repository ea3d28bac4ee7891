"""Operators on pixel relations: gray(image_id, y, x, v) or pixels(image_id, y, x, b, g, r), all images at once."""
