"""The mixed-membership model: components with a mutation signature and a rate over loci."""
