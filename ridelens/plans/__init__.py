"""Query catalogue, SQL oracle, question suite and plan inspection."""
