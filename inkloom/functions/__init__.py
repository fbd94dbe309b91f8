"""Part of inkloom."""
