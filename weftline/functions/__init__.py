"""Part of the weftline package; see README.md."""
