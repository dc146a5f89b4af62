"""Plans of questions, as literals on the driver and as columns."""
