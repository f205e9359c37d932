"""Array kernels in numpy: what works on one page, word or pair of blocks at a time."""
