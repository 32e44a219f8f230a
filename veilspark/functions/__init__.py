"""Part of veilspark; see README.md."""
