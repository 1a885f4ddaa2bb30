"""Plans that span several jobs: written tables and iterated joins."""
