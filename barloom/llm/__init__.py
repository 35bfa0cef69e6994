"""Training-data operators over a `documents` table; nothing outside this package imports it."""
