"""Knowledge bases over tables, and the fixpoint loop their operators share."""
