"""Arrays have no streams: they are dense and finite, and writing block by block is the Parquet sink's own work.

The package is kept for the layout; there is nothing in it on purpose.
"""
