"""Sources: landed API pages, source trees, archives and earlier reports."""
