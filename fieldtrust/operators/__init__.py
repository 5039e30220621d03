"""DataFrame -> DataFrame jobs; no action inside, except where a model is fitted."""
