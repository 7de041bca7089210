"""Running pileups over streams of observations."""
