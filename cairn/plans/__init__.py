"""What the driver decides before a plan runs: policies, rules, queries, markers."""
