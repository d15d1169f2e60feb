"""Readers: KML documents, zipped Shapefiles, JSON Lines features and manifests."""
