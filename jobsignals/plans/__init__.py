"""End-to-end jobs: raw folders to features, features to results, results to a report."""
