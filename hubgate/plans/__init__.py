"""Plans: blocked all-pairs passes and the retrieval analysis built on them."""
