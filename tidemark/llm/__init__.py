"""Training-data operators: sharding, scanning, deduplication, mixing and output.

Nothing outside this subpackage imports it.  Every operator keeps its own general
interface; ``queries.py`` registers the thin ``opN_<name>`` queries.
"""
