"""DataFrame operators over runs, images, deposits, logs and attempts."""
