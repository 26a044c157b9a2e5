"""Row, cell, pair and model operators over evaluation rows."""
