"""Part of loomtrace."""
