"""Windows over event time, for batches and streams alike, and views that follow a stream."""
