"""End-to-end batch plans over tables of requests."""
