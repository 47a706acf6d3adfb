"""Plan building blocks: staging, ordered prefixes, exact quantiles, sparse products."""
