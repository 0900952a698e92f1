"""Row identity, record linkage and differences."""
