"""Readers and writers: file listings, images, thumbnails, table snapshots."""
