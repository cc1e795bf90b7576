"""Column functions and driver-side helpers of the rules they are made of."""
