"""Where rows come from and go to: registry, logs, scratch tables, stored objects."""
