"""From the bytes of a page to a structured record. Everything but :mod:`leafwright.pages.record` works on one page and needs no Spark."""
