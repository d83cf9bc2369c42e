"""How plans are cut and sized: tables in the shared folder, and size-checked broadcast."""
