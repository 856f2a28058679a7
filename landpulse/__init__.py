"""Land-acquisition analytics as Spark jobs: timelines, quality, modelling, risk."""
