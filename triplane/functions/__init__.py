"""Terms and expressions as native columns."""
