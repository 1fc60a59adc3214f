"""Growing a structure set by proposing, judging and keeping new structures."""
