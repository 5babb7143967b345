"""Bronze -> silver scans of the four feeds, plus inline tables and journey specs."""
