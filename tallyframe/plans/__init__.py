"""What a user calls: whole jobs composed of the operators."""
