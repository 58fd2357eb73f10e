"""Reading delivered and processed tables, writing processed and published ones."""
