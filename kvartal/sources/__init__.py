"""Reading crawled pages, catalogs and snapshots; writing outboxes."""
