"""Driver-side algebra: element types, shapes and alignment. Nothing here runs a job."""
