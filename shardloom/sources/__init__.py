"""Catalogs, manifests, sharded storage and COPY formats."""
